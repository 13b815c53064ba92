"""Stream definitions: parsing, analysis and plans."""
