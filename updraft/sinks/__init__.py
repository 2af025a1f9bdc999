"""Writers: price store, screen results, notification ledger."""
