"""Query catalogues and the page-generator builder."""
