"""End-to-end plans assembled from the operators."""
