"""Writers for edit tables, vectors, ground truth and evaluation reports."""
