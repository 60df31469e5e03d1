"""rankloom: ranked-retrieval analytics written as Spark DataFrame operators."""
