"""Reading raw pages and templates; writing documents."""
