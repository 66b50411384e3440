"""Where trees come from and go to."""
