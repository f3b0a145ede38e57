"""PySpark jobs for bank-statement data: parsing, ledgers, records, accounts and event streams."""
