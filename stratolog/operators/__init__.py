"""DataFrame operators over changelogs."""
