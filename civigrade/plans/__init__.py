"""Named queries over the shared tables, each with the plain SQL that must give the same rows."""
