"""Document intelligence on Spark: text repair, layout, extraction, summaries, arbitration and rendering."""
