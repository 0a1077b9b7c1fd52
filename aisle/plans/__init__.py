"""Plan shapes that stay balanced when one key holds a large share of the rows."""
