"""lodeflow: composable DataFrame operators and the queries built from them."""
