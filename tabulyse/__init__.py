"""tabulyse: profile, clean, synthesize and meter tables with PySpark."""
