"""offerlens.sources"""
