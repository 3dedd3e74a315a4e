"""corpusloom: keyed-corpus analytics expressed as Spark DataFrame plans."""
