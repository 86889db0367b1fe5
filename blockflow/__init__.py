"""blockflow: OCR and translation corpora as Spark tables."""

__version__ = "0.1.0"
