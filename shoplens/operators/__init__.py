"""DataFrame -> DataFrame operators over the clean order fact."""
