"""Ready-made queries over the driver's tables and inline samples."""
