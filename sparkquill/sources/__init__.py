"""File sources and table stores."""
