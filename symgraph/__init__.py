"""symgraph: code-structure and corpus analytics written as Spark DataFrame jobs."""
