"""pitchlake: competition analytics as composable DataFrame and Column transformations."""
