"""Tables, ledgers and the layered pipeline."""
