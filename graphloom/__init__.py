"""Graph analytics on Spark: SPARQL queries and updates, rules, closures and incremental maintenance as DataFrame plans."""
