"""touchline.plans"""
