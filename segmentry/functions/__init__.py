"""Column functions: replies, prompts, preferences, rewards, vectors and draws. None of them touches a DataFrame."""
