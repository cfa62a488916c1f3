"""sheafwork: document and table intelligence expressed as Spark DataFrame jobs."""
