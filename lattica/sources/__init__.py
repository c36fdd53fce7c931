"""Where bytes come from and go to."""
