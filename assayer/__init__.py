"""Record evaluation, curation and corpus preparation as Spark plans."""
