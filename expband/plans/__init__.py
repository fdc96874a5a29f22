"""End-to-end jobs: train, evaluate and score."""
