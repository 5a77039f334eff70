"""Plan shapes shared by the operators: segmented scans, halos, anchored groups, interval joins."""
