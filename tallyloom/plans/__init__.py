"""Read side: list, report and ad-hoc queries over the ledger."""
