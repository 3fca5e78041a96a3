"""Document-corpus engine on Spark: chunking, citation graph, batch retrieval, audits and bulk decision-tree evaluation."""
