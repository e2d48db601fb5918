"""DataFrame-to-DataFrame forensic operators."""
