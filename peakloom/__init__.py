"""Clustered tandem mass spectra on Spark: layout for clustering, consensus spectra, MGF and MSP text."""
