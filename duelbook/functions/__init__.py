"""Column expressions and parameter checks shared by every operator."""
