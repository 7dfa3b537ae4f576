"""DataFrame operators: timing, alignment, layout, screening, cutting, speakers, scores."""
