"""Building blocks shared by the operators: files, scratch tables, global numbering."""
