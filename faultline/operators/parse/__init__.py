"""Line parsing as column expressions. One module per log format; ``dispatch`` runs them over many logs at once."""
