"""Model fitting: grouped block jobs, scalar searches and the alternating loop."""
