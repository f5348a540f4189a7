"""A PySpark analytics engine for image-derived biomarker cohorts with ordinal outcomes."""
