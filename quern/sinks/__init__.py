"""Writers: content-addressed tables, version archives, exports."""
