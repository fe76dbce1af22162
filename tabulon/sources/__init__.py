"""Cell-grid and page sources, file sinks."""
