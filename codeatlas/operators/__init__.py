"""DataFrame -> DataFrame operators over the files / elements / edges / docs tables."""
