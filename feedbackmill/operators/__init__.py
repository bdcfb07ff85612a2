"""DataFrame transforms: numbering, ranking, dashboards, aspects, terms, topics and sentiment."""
