"""Writers: ledgers, summaries, histories, images."""
