"""Writers of records, tables and nested documents."""
