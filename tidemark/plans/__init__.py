"""Named queries over the driver's tables, each with the same result in plain SQL where SQL can express it."""
