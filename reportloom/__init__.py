"""Analytics over administrative reports, declared on the DataFrame API."""
