"""quernstone: a Spark-first engine for scoring, calibrating and ranking keyed entities."""
