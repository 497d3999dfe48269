"""Where corpora come from and go to."""
