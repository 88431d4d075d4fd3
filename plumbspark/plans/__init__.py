"""Multi-step jobs built from the operators: check runs, reports, published writes."""
