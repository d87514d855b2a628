"""Operators: DataFrame in, DataFrame out, nothing executed until the caller asks for rows."""
