"""webspark subpackage."""
