"""The pipeline steps: sessions, orders, features, model, refresh."""
