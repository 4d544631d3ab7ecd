"""Relational, graph, embedding and recommendation operators: DataFrame in, DataFrame out."""
