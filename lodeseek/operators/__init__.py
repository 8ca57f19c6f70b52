"""Part of lodeseek."""
