"""sitelake: Spark DataFrame operators for labelled, scored sequence positions."""
