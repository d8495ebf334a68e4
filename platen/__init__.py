"""platen: document layout analytics over collections of PDF files, on PySpark."""
