"""Sources: the bronze CSV landing, the stand-in adapter, and layer storage."""
