"""Named queries over the library's operators."""
