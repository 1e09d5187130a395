"""tallyloom: DataFrame operators for auditing, conditioning and comparing probability-vector data at scale."""
