"""Nothing here is a stream: the datasets explored are files that do not change."""
