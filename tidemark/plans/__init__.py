"""The question catalogue and the queries registered over the test tables."""
