"""The batch operators over file drops."""
