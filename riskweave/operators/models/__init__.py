"""Unsupervised anomaly models as Spark jobs: scalers, isolation forest,
autoencoder, linear (PCA) reconstruction, thresholds and artifacts."""
