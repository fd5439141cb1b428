"""Where snapshots come from and go to: stored tables, text files, run history, file trees."""
