"""Search operators over DataFrames of `(id, vector)`."""
