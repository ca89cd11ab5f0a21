"""weftgraph: a graph-mining and analytics engine expressed as Spark DataFrame plans."""
