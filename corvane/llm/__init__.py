"""Training-data operators: each module holds one operator, `queries` holds their thin contract queries."""
