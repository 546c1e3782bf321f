"""Where cells come from and go to: the catalog's tables, TSV and CSV text, exports."""
