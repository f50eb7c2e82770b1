"""Ledgerflow: delivery-ledger analytics on PySpark.

Record streams, attempts, acknowledgements, ownership epochs, commit positions, dead letters and metrics are relations;
every mechanism of message delivery is a DataFrame transformation over them.
"""
