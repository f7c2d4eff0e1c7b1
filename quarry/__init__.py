"""Quarry: a Spark-first mining engine (relational, itemset, graph, cluster, stream operators)."""
