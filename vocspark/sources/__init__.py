"""Raw landed records → canonical feedback rows, one module per kind of source."""
