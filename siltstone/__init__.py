"""A transactional table layer and data-processing operators for PySpark."""
