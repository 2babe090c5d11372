"""Graph-augmented document analytics as plain DataFrame-to-DataFrame functions."""
