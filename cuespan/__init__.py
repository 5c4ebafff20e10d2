"""cuespan: narrated-timeline analytics as Spark DataFrame operators."""
