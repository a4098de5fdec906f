"""Sources: the file-tree data source, content loading, exports and record lines."""
