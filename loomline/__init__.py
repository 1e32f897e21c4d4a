"""loomline: record handling and corpus preparation as Spark DataFrame operators."""
