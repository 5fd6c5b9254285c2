"""The hourly roll-up on a growing folder of logger files."""
