"""The three end-to-end jobs: exploration, classifier training and segmentation."""
