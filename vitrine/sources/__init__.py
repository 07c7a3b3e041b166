"""Where rows come from and go to: Parquet footers, the row-group source, the generated dataset."""
